"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other training texts count as unlabelled,
toxic ones among them included.  A linear model on the set of a text's words minimises
``prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))``; while the second part is negative
the step goes against it, so a flexible model cannot push it below zero.

The model is fitted with numpy on at most about ``max_positives`` and ``max_unlabelled``
texts, drawn by a hash of the text; the class prior is the toxic share of all labelled
training rows, and scoring covers every text.  The vocabulary is the words of the sample
that occur in ``min_texts`` of its texts or more and whose log ratio between positives and
unlabelled texts is ``contrast`` standard errors or more from 0.

Defined cases: a NULL or blank text has no words and gets the score of the bias alone; a
row without an id is held out, as no label names it; where labels repeat, a row counts as
toxic if any says so; without a toxic training row every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .licenses import text_words
from .sampling import bounded_draw


@dataclass
class Model:
    vocabulary: np.ndarray
    weights: np.ndarray
    bias: float


def text_word_sets(words: np.ndarray, at: np.ndarray, vocabulary: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, word) pairs; words are positions in the vocabulary where one is given."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    if vocabulary is not None:
        if not len(vocabulary):
            return text[:0], text[:0]
        near = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
        known = vocabulary[near] == words
        pairs = np.unique(text[known] * len(vocabulary) + near[known])
        return pairs // len(vocabulary), pairs % len(vocabulary)
    order = np.lexsort((words, text))
    text, words = text[order], words[order]
    new = np.ones(len(words), bool)
    new[1:] = (text[1:] != text[:-1]) | (words[1:] != words[:-1])
    return text[new], words[new]


def word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in tokens.slices(batch, "text"):
            text, words = text_word_sets(*text_words(*tokens.utf8(piece.column("text"))))
            offsets = np.searchsorted(text, np.arange(piece.num_rows + 1)).astype(np.int32)
            sets = pa.ListArray.from_arrays(offsets, pa.array(words.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([piece.column("toxic"), sets], ["toxic", "words"])


def scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tokens.slices(batch, "text"):
                text, word = text_word_sets(*text_words(*tokens.utf8(piece.column("text"))), model.vocabulary)
                z = np.bincount(text, model.weights[word], piece.num_rows) + model.bias
                score = np.where(np.isneginf(z), 0.0, 1 / (1 + np.exp(-np.clip(z, -500, 500))))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), piece.column("held_out"), pa.array(score)], ["id", "held_out", "score"])
    return run


def fit(
    sets: list[np.ndarray], toxic: np.ndarray, prior: float, min_texts: int = 5, contrast: float = 3.0,
    epochs: int = 300, rate: float = 0.05, decay: float = 2e-4,
) -> Model:
    """Minimise the non-negative risk with the logistic loss, by Adam on all rows of the sample."""
    words, counts = np.unique(np.concatenate(sets), return_counts=True)
    words = words[counts >= min_texts]
    begins = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    row, word = text_word_sets(np.concatenate(sets), begins, words)
    # Words about as frequent in both parts carry no risk gradient but noise: they are left out.
    in_p = np.bincount(word[toxic[row]], minlength=len(words)) + 0.5
    in_u = np.bincount(word[~toxic[row]], minlength=len(words)) + 0.5
    ratio = np.log(in_p / toxic.sum()) - np.log(in_u / (~toxic).sum())
    chosen = np.abs(ratio) >= contrast * np.sqrt(1 / in_p + 1 / in_u)
    vocabulary = words[chosen]
    row, word = text_word_sets(np.concatenate(sets), begins, vocabulary)
    n, size = len(sets), len(vocabulary)
    weights, momentum, square = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    weights[-1] = np.log(prior / (1 - prior))
    p, u = toxic, ~toxic
    for epoch in range(1, epochs + 1):
        z = np.bincount(row, weights[word], n) + weights[-1]
        up = 1 / (1 + np.exp(-z))  # derivative of the loss as a negative; that as a positive is up - 1
        loss_n = np.logaddexp(0, z)
        rest = loss_n[u].mean() - prior * loss_n[p].mean()
        slope = np.zeros(n)
        if rest >= 0:
            slope[p] = prior * (up[p] - 1) / p.sum() - prior * up[p] / p.sum()
            slope[u] = up[u] / u.sum()
        else:
            slope[p] = prior * up[p] / p.sum()
            slope[u] = -up[u] / u.sum()
        grad = np.append(np.bincount(word, slope[row], size), slope.sum())
        grad[:-1] += decay * weights[:-1]
        momentum = 0.9 * momentum + 0.1 * grad
        square = 0.999 * square + 0.001 * grad * grad
        weights -= rate * (momentum / (1 - 0.9**epoch)) / (np.sqrt(square / (1 - 0.999**epoch)) + 1e-8)
    return Model(vocabulary, weights[:-1], float(weights[-1]))


def held_out(id_column: str) -> Column:
    """A fifth of the ids, whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
    max_positives: int = 4_000, max_unlabelled: int = 8_000, max_bytes: int = 64 << 20,
) -> Model:
    """Learn from at most ``max_positives`` toxic and ``max_unlabelled`` other rows, each part with at most ``max_bytes`` of text.

    Both are drawn by a hash of id and text, so copies under several ids are drawn one by one.
    """
    marks = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("toxic"))
    marks = marks.where(~held_out("id")).groupBy("id").agg(F.max("toxic").alias("toxic")).where("toxic IS NOT NULL")
    n_toxic, n_marked = marks.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), -np.inf)
    if not n_toxic:
        return nothing
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).where(~held_out("id"))
    # Ids first: only a bounded number of them goes to the texts, so the texts do not move.
    ids = bounded_draw(marks.where("toxic = 1").select("id"), ["id"], None, max_positives)
    chosen = bounded_draw(texts.join(ids, "id"), ["id", "text"], "text", max_positives, max_bytes).select(F.lit(True).alias("toxic"), "text")
    # Toxic rows of the draw belong to the unlabelled part too; their labels are not used.
    unlabelled = bounded_draw(texts, ["id", "text"], "text", max_unlabelled, max_bytes).select(F.lit(False).alias("toxic"), "text")
    sample = chosen.unionByName(unlabelled).mapInArrow(word_sets, "toxic boolean, words array<bigint>").toArrow()
    toxic = np.array(sample.column("toxic").to_pylist(), bool)
    sets = [np.array(w.values).view(np.uint64) for w in sample.column("words")]
    if not toxic.any() or toxic.all():
        return nothing
    order = sorted(range(len(sets)), key=lambda i: (bool(toxic[i]), sets[i].tobytes()))
    return fit([sets[i] for i in order], toxic[order], min(0.9, n_toxic / n_marked))


def score_toxicity(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, held_out, score in [0, 1], predicted (score >= 0.5)."""
    texts = docs.select(
        F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"), held_out(id_column).alias("held_out"))
    out = texts.mapInArrow(scorer(model), "id bigint, held_out boolean, score double")
    return out.select(F.col("id").alias(id_column), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
