"""N-best segmentation into sentence pieces, and exact decoding.

A text is cut by the scores of a given piece model (never trained here): the best cuts are
the paths of largest score through the lattice of pieces.  A forward Viterbi pass gives the
best score up to each character; that is the exact remaining score of a path built backward
from the end, so a backward A* search with it as heuristic finds the N best paths in order.

White space starts a piece and never stands inside one, so a path may be cut before each
white space, and around characters that are in no piece: the lattice of a text is a row of
independent word lattices.  The Viterbi pass runs over all new words of a batch at once in
numpy (forward, and backward for each word's loss to its second best path); found words are
numbered and stay in flat arrays of about ``CACHE`` words, from which a text gathers its ids.  The N best of a text deviate from the best only in the
words with the N smallest losses, any other choice being worse than these N, so A* searches
those words alone.

A character without a piece (and a literal U+2581, which stands for a space in pieces) is
written as its UTF-8 bytes, so decoding gives back every text exactly.

Defined cases: a NULL or empty text has no pieces and score 0; ties are settled by the order
of the search and do not depend on the rows around; a text with fewer than N segmentations
has all of them; rows that repeat give equal results.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

SPACE = "▁"
CACHE = 400_000
LONGEST_WORD = 48
# Entries of the lattices that one pass works on.
LATTICE = 1 << 18
LEAD_BITS = 20
# A literal space sign of a text on its way through the lattice; no piece and no text has it.
LITERAL = "\ud800"


class Pieces:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, model: bytes, n_best: int):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.n_best = n_best
        self.names = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        self.byte_ids = {int(self.names[i][1:-1], 16): i for i in range(len(self.names)) if p.is_byte(i)}
        self.bytes_of = {i: bytes([b]) for b, i in self.byte_ids.items()}
        plain = [i for i in range(len(self.names)) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        self.scores = {self.names[i]: (i, p.get_score(i)) for i in plain}
        self.longest = max(map(len, self.scores))
        self.unknown = min(s for _, s in self.scores.values()) - 10.0
        inner = any(SPACE in name.lstrip(SPACE) for name in self.scores)
        # Where a space may stand inside a piece, a text is one lattice.
        self.cut = re.compile(r"(?s).+" if inner else rf"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
        self.searched: dict[str, list] = {}
        self.forget()
        self.raw = [self.bytes_of.get(i) or name.replace(SPACE, " ").encode() for i, name in enumerate(self.names)]
        # Pieces by a hash of their characters, for the passes over many words at once.
        base = np.uint64(0xD1342543DE82EF95)
        self.powers = tokens.powers(LONGEST_WORD + 1, base)
        self.back = tokens.powers(LONGEST_WORD + 1, np.uint64(pow(int(base), -1, 1 << 64)))
        hashes = []
        for name in self.scores:
            chars = np.array([ord(c) + 1 for c in name], np.uint64)
            hashes.append(int((tokens.mix(chars) * self.powers[:len(chars)]).sum() + np.uint64(len(chars))))
        order = np.argsort(np.array(hashes, np.uint64))
        self.hashes = np.append(np.array(hashes, np.uint64)[order], np.uint64(0))
        if (self.hashes[1:-1] == self.hashes[:-2]).any():
            raise ValueError("two pieces share a hash")
        # The last entry stands for no piece.
        none = len(order)
        self.hash_ids = np.append(np.array([i for i, _ in self.scores.values()], np.int32)[order], np.int32(-1))
        self.hash_scores = np.append(np.array([s for _, s in self.scores.values()])[order], -np.inf)
        # The first piece whose hash begins with given bits, and for each piece the next one with the same bits.
        lead = (self.hashes[:-1] >> np.uint64(64 - LEAD_BITS)).astype(np.int64)
        self.first = np.full(1 << LEAD_BITS, none, np.int32)
        self.first[lead[::-1]] = np.arange(none - 1, -1, -1)
        self.after = np.full(none + 1, none, np.int32)
        self.after[:none - 1][lead[1:] == lead[:-1]] = np.flatnonzero(lead[1:] == lead[:-1]) + 1
        self.most = int(np.bincount(lead).max()) if none else 0

    def forget(self) -> None:
        """Empty the arrays of known words."""
        self.number: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.score, self.loss = np.zeros(1 << 12), np.zeros(1 << 12)

    def remember(self, words: list[str], ids: np.ndarray, sizes: np.ndarray, scores: np.ndarray, losses: np.ndarray) -> None:
        """Number new words; ``ids`` are those of their best paths, one word after the other."""
        at, end = len(self.number), len(self.number) + len(words)
        self.flat = _room(self.flat, self.used + len(ids))
        for name, values in (("start", self.used + np.cumsum(sizes) - sizes), ("size", sizes), ("score", scores), ("loss", losses)):
            grown = _room(getattr(self, name), end)
            grown[at:end] = values
            setattr(self, name, grown)
        self.flat[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        self.number.update(zip(words, range(at, end), strict=True))

    def pieces_at(self, h: np.ndarray) -> np.ndarray:
        """The entry of the piece with each hash."""
        at = self.first[(h >> np.uint64(64 - LEAD_BITS)).astype(np.int64)]
        for _ in range(self.most):
            wrong = self.hashes[at] != h
            at[wrong] = self.after[at[wrong]]
        return at

    def search(self, word: str) -> list[tuple[float, list[int]]]:
        """The N best (score, ids) of one word."""
        n, lookup = len(word), self.scores.get
        into: list[list[tuple[int, list[int], float]]] = [[] for _ in range(n + 1)]
        best = [0.0] + [-np.inf] * n
        for end in range(1, n + 1):
            arcs = into[end]
            for start in range(max(0, end - self.longest), end):
                found = lookup(word[start:end])
                if found:
                    arcs.append((start, [found[0]], found[1]))
            if not arcs or arcs[-1][0] != end - 1:
                char = SPACE if word[end - 1] == LITERAL else word[end - 1]
                arcs.append((end - 1, [self.byte_ids[b] for b in char.encode()], self.unknown))
            best[end] = max(best[start] + score for start, _, score in arcs)
        out: list[tuple[float, list[int]]] = []
        count = 0
        heap = [(-best[n], 0, n, 0.0, None)]
        while heap and len(out) < self.n_best:
            _, _, at, done, chain = heapq.heappop(heap)
            if at == 0:
                ids: list[int] = []
                while chain is not None:
                    ids += chain[0]
                    chain = chain[1]
                out.append((done, ids))
                continue
            for start, ids, score in into[at]:
                count += 1
                heapq.heappush(heap, (-(done + score + best[start]), count, start, done + score, (ids, chain)))
        return out

    def ranked(self, word: str) -> list[tuple[float, list[int]]]:
        """The N best of a word, from the cache of searched words."""
        found = self.searched.get(word)
        if found is None:
            if len(self.searched) >= CACHE:
                self.searched.clear()
            found = self.searched[word] = self.search(word)
        return found

    def learn(self, words: set[str]) -> None:
        """Number the words that are not known yet: ids of the best path, its score, loss of the second best."""
        if len(self.number) >= CACHE:
            self.forget()
        by_length: dict[int, list[str]] = {}
        for word in words.difference(self.number):
            by_length.setdefault(len(word), []).append(word)
        for length, same in by_length.items():
            rest, step = same, max(64, LATTICE // (length * min(self.longest, length)))
            if length <= LONGEST_WORD:
                rest = [w for at in range(0, len(same), step) for w in self._viterbi(same[at:at + step], length)]
            for word in rest:
                ranked = self.ranked(word)
                loss = ranked[0][0] - ranked[1][0] if len(ranked) > 1 else np.inf
                ids = np.array(ranked[0][1], np.int32)
                self.remember([word], ids, np.array([len(ids)]), np.array([ranked[0][0]]), np.array([loss]))

    def _viterbi(self, words: list[str], n: int) -> list[str]:
        """Forward and backward pass over words of one length; words with a character without a piece are left.

        Arrays go by (size of the piece, where it begins, word).
        """
        b, reach = len(words), min(self.longest, n)
        chars = np.array(words, dtype=f"U{n}").view(np.uint32).reshape(b, n).T.astype(np.uint64)
        sums = np.zeros((n + 1, b), np.uint64)
        np.cumsum(tokens.mix(chars + np.uint64(1)) * self.powers[:n, None], axis=0, out=sums[1:])
        arcs, names = np.full((reach, n, b), -np.inf), np.full((reach, n, b), -1, np.int32)
        for size in range(1, reach + 1):
            at = self.pieces_at((sums[size:] - sums[:n - size + 1]) * self.back[:n - size + 1, None] + np.uint64(size))
            arcs[size - 1, :n - size + 1] = self.hash_scores[at]
            names[size - 1, :n - size + 1] = self.hash_ids[at]
        whole = (arcs[0] > -np.inf).all(axis=0)
        ahead, step, back = np.zeros((n + 1, b)), np.zeros((n + 1, b), np.int64), np.zeros((n + 1, b))
        for end in range(1, n + 1):
            best, by = ahead[end - 1] + arcs[0, end - 1], np.ones(b, np.int64)
            for size in range(2, min(reach, end) + 1):
                other = ahead[end - size] + arcs[size - 1, end - size]
                by[other > best] = size
                np.maximum(best, other, out=best)
            ahead[end], step[end] = best, by
        for start in range(n - 1, -1, -1):
            k = min(reach, n - start)
            back[start] = (arcs[:k, start] + back[start + 1:start + 1 + k]).max(axis=0)
        for size in range(1, reach + 1):
            arcs[size - 1, :n - size + 1] += ahead[:n - size + 1]
            arcs[size - 1, :n - size + 1] += back[size:]
        path, at, count = np.full((b, n), -1, np.int32), np.full(b, n), np.zeros(b, np.int64)
        while (going := at > 0).any():
            r, end = np.flatnonzero(going), at[going]
            size = step[end, r]
            start = end - size
            path[r, n - 1 - count[r]] = names[size - 1, start, r]
            arcs[size - 1, start, r] = -np.inf
            count[r] += 1
            at[going] = start
        loss = np.where(whole, ahead[n], 0.0) - arcs.max(axis=(0, 1))
        path = path[whole]
        self.remember([w for w, ok in zip(words, whole.tolist(), strict=True) if ok], path[path >= 0], count[whole], ahead[n][whole], loss[whole])
        return [w for w, ok in zip(words, whole.tolist(), strict=True) if not ok]

    def words(self, text: str) -> list[str]:
        return self.cut.findall(SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> tuple[np.ndarray, list[float], list[np.ndarray]]:
        """Ids of the best segmentation, and scores and ids of the N best."""
        words = self.words(text)
        self.learn(set(words))
        return self.encode_words(words)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, list[float], list[np.ndarray]]:
        """The same for a text whose words are known."""
        if not words:
            return np.zeros(0, np.int32), [0.0], [np.zeros(0, np.int32)]
        numbers = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        sizes, losses = self.size[numbers], self.loss[numbers]
        ends = np.cumsum(sizes)
        begins = ends - sizes
        ids = self.flat[np.repeat(self.start[numbers] - begins, sizes) + np.arange(int(ends[-1]))]
        total = float(np.sum(self.score[numbers]))
        k = min(self.n_best, len(losses))
        near = np.argpartition(losses, k - 1)[:k] if k < len(losses) else np.arange(k)
        near = near[np.lexsort((near, losses[near]))]
        choices: list[tuple[float, tuple]] = [(0.0, ())]
        for i in near.tolist():
            ranked = self.ranked(words[i])
            wider = [(loss + ranked[0][0] - ranked[r][0], picks + (((i, r),) if r else ()))
                     for loss, picks in choices for r in range(len(ranked))]
            choices = heapq.nsmallest(self.n_best, wider)
        every = []
        for _, picks in choices:
            parts, at = [], 0
            for i, r in sorted(picks):
                parts += [ids[at:begins[i]], np.array(self.ranked(words[i])[r][1], np.int32)]
                at = ends[i]
            every.append(np.concatenate([*parts, ids[at:]]) if picks else ids)
        return ids, [total - loss for loss, _ in choices], every

    def decode(self, ids: np.ndarray) -> str:
        """The text of any of its segmentations."""
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


def _room(values: np.ndarray, n: int) -> np.ndarray:
    """The array, copied to one of twice the size until it has ``n`` entries."""
    while len(values) < n:
        values = np.concatenate([values, np.zeros(len(values), values.dtype)])
    return values


_LOADED: dict[tuple, Pieces] = {}


def loaded(model: bytes, n_best: int) -> Pieces:
    """One instance per worker process, so the cache lasts over tasks."""
    key = (hashlib.sha256(model).digest(), n_best)
    if key not in _LOADED:
        _LOADED[key] = Pieces(model, n_best)
    return _LOADED[key]


def encode_texts(
    docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text", n_best: int = 3,
) -> DataFrame:
    """Per row: id, n_pieces, scores (N best, descending), ids of the best segmentation, the SHA-256 of each
    segmentation's ids, and whether the best decodes to the text.

    The model file is read on the driver (a vocabulary of fixed size) and sent with the tasks.
    """
    with open(model_path, "rb") as file:
        model = file.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model, n_best)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                ids, scores, digests, exact = [], [], [], []
                texts = part.column("text").to_pylist()
                cut = [pieces.words(text or "") for text in texts]
                pieces.learn(set().union(*cut))
                for text, words in zip(texts, cut, strict=True):
                    best, ranked, every = pieces.encode_words(words)
                    ids.append(best)
                    scores.append(ranked)
                    digests.append([hashlib.sha256(x.tobytes()).hexdigest() for x in every])
                    exact.append(pieces.decode(best) == (text or ""))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(scores, pa.list_(pa.float64())),
                     pa.array(digests, pa.list_(pa.string())), pa.array(exact, pa.bool_()), pa.array(ids, pa.list_(pa.int32()))],
                    ["id", "n_pieces", "scores", "digests", "decoded_equal", "ids"])

    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"))
    out = rows.mapInArrow(run, "id bigint, n_pieces bigint, scores array<double>, digests array<string>, decoded_equal boolean, ids array<int>")
    return out.withColumnRenamed("id", id_column)
