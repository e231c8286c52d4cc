"""License scans by diagonal voting.

All rolling word k-grams of a text are hashed and joined to the positions of the same
k-grams in the license templates.  A hit lies on the diagonal "text position minus
template position"; votes are counted per text, template and diagonal, neighbouring
diagonals (a few words inserted or left out) are merged into spans, and a span is
verified on the words: the share of the template that stands there in order.  A template of
fewer than ``SHORT`` words needs votes for half of its grams, and must stand there in full.

Before the join each task leaves out grams whose hash is in no template (templates are
part of the program, so their table is small at any input size).  Verification sees only
texts with a span of enough votes.

Defined cases: a NULL or empty text has no words, labels '' and score 0; the score of a
named phrase is 1, else the largest share of a verified template.  Each row is judged on
its own, so repeated rows and rows without an id give equal results of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .license_texts import PHRASES, TEMPLATES
from .store import written

# Templates with fewer words are notices of one line, which differ in a word or a number.
SHORT = 20
FIRST = ("row bigint, id bigint, n_words bigint, places array<struct<label:string,start:bigint>>,"
         " grams array<struct<start:bigint,hash:bigint>>, text string")


def text_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text begins among them."""
    data = tokens.LOWER[data]
    starts, ends = tokens.words(data, off, tokens.NOT_ALNUM)
    return tokens.span_hashes(data, starts, ends), tokens.counts_by_text(starts, off)


def hashed(text: str) -> np.ndarray:
    raw = text.encode()
    return text_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]


def phrase_starts(words: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    n = max(0, len(words) - len(phrase) + 1)
    hit = np.ones(n, bool)
    for j, w in enumerate(phrase):
        hit &= words[j:j + n] == w
    return np.flatnonzero(hit)


def votes_needed(length: int, k: int, votes: int) -> int:
    """Votes for a template of so many words: half of its grams, ``votes`` at most."""
    return min(votes, max(1, -(-(length - k + 1) // 2)))


def first_pass(k: int, votes: int):
    """Named phrases and template grams of each text; the text itself where a span is possible."""
    phrases = [(hashed(p), label) for p, label in PHRASES.items()]
    least = min(votes_needed(len(hashed(t)), k, votes) for t in TEMPLATES.values())
    wanted = np.unique(np.concatenate([tokens.gram_hashes(hashed(t), k) for t in TEMPLATES.values()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in tokens.slices(batch, "text"):
                words, at = text_words(*tokens.utf8(piece.column("text")))
                n = piece.num_rows
                places: list[list] = [[] for _ in range(n)]
                grams: list[list] = [[] for _ in range(n)]
                # Hits of all texts at once; one that runs over the end of its text is left out.
                for phrase, label in phrases:
                    for s in phrase_starts(words, phrase):
                        t = int(np.searchsorted(at, s, "right")) - 1
                        if s + len(phrase) <= at[t + 1]:
                            places[t].append({"label": label, "start": int(s - at[t])})
                hashes = tokens.gram_hashes(words, k)
                near = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
                for s in np.flatnonzero(wanted[near] == hashes):
                    t = int(np.searchsorted(at, s, "right")) - 1
                    if s + k <= at[t + 1]:
                        grams[t].append({"start": int(s - at[t]), "hash": int(hashes[s].astype(np.int64))})
                shown = pa.array([len(g) >= least for g in grams], pa.bool_())
                text = piece.column("text")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), piece.column("id"), pa.array(np.diff(at)),
                     pa.array(places, pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))),
                     pa.array(grams, pa.list_(pa.struct([("start", pa.int64()), ("hash", pa.int64())]))),
                     pa.array([x if keep.as_py() else None for x, keep in zip(text.to_pylist(), shown, strict=True)], pa.string())],
                    ["row", "id", "n_words", "places", "grams", "text"])
                row += n
    return run


def verifier(slack: int):
    """The share of the template's words that stand in order in the span."""
    templates = {label: hashed(t) for label, t in TEMPLATES.items()}

    def share(words: np.ndarray, template: np.ndarray) -> float:
        # Longest common subsequence, one row of the table per word of the span.
        best = np.zeros(len(template) + 1, np.int64)
        for w in words:
            step = best.copy()
            step[1:] = np.maximum(best[1:], np.where(template == w, best[:-1] + 1, 0))
            best = np.maximum.accumulate(step)
        return best[-1] / len(template)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = []
            for text, label, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "lo", "hi")), strict=True):
                wider = 0 if len(templates[label]) < SHORT else slack
                shares.append(share(hashed(text)[max(0, lo - wider):hi + wider], templates[label]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "label", "lo", "hi", "votes")), pa.array(shares, pa.float64())],
                ["row", "label", "lo", "hi", "votes", "share"])
    return run


def template_grams(spark, k: int, votes: int) -> DataFrame:
    """The grams of all templates with their positions, and the votes that their template needs."""
    rows = [(label, votes_needed(len(hashed(t)), k, votes), i, int(h)) for label, t in TEMPLATES.items()
            for i, h in enumerate(tokens.gram_hashes(hashed(t), k).astype(np.int64))]
    return spark.createDataFrame(rows, "label string, needed int, position int, hash bigint")


def license_spans(found: DataFrame, k: int, votes: int, gap: int) -> DataFrame:
    """Spans of merged diagonals: row, label, lo, hi, votes."""
    hits = found.where(F.col("text").isNotNull()).select("row", F.explode("grams").alias("g"))
    hits = hits.select("row", F.col("g.start").alias("start"), F.col("g.hash").alias("hash"))
    hits = hits.join(F.broadcast(template_grams(found.sparkSession, k, votes)), "hash")
    diagonals = hits.groupBy("row", "label", "needed", (F.col("start") - F.col("position")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("start").alias("lo"), (F.max("start") + k).alias("hi"))
    order = Window.partitionBy("row", "label").orderBy("diagonal")
    begins = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > gap).cast("int"), F.lit(1))
    merged = diagonals.withColumn("part", F.sum(begins).over(order))
    return merged.groupBy("row", "label", "needed", "part").agg(
        F.sum("votes").alias("votes"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("votes >= needed").drop("part", "needed")


def scan_licenses(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    k: int = 4, votes: int = 6, gap: int = 8, least_share: float = 0.5,
) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score and verified ``spans``."""
    texts = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"))
    found = written(texts.mapInArrow(first_pass(k, votes), FIRST), "licenses")
    spans = license_spans(found, k, votes, gap)
    checked = spans.join(found.where(F.col("text").isNotNull()).select("row", "text"), "row").mapInArrow(
        verifier(gap), "row bigint, label string, lo bigint, hi bigint, votes bigint, share double")
    short = [label for label, t in TEMPLATES.items() if len(hashed(t)) < SHORT]
    checked = checked.where(F.col("share") >= F.when(F.col("label").isin(short), 1.0).otherwise(least_share))
    checked = checked.withColumn("label", F.substring_index("label", ":", 1))
    by_row = checked.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("label", "lo", "hi", "votes", "share"))).alias("spans"), F.max("share").alias("share"))
    base = F.array_distinct(F.col("places.label"))
    names = F.array_union(base, F.coalesce(F.col("spans.label"), F.array().cast("array<string>")))
    starts = F.col("places.start")
    return found.join(by_row, "row", "left").select(
        F.col("id").alias(id_column), "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"), F.array_join(F.sort_array(names), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.least(F.coalesce("share", F.lit(0.0)), F.lit(1.0))).alias("score"),
        F.coalesce("spans", F.array().cast("array<struct<label:string,lo:bigint,hi:bigint,votes:bigint,share:double>>")).alias("spans"))
