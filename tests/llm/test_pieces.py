import hashlib

import numpy as np
import pytest

from tablewash.llm import pieces
from tablewash.llm.queries import piece_model

TEXTS = ["", "a", "the cat sat", "hello  world\n\tagain", "x▁y", "é😀 ￿ end", "unbelievable internationalisation", "a a a b"]


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(open(piece_model(), "rb").read(), 3)


def brute(p, text, n):
    """The n best (score, ids) of a whole text: all cuts of every prefix, the best n kept."""
    if not text:
        return [(0.0, ())]
    s = pieces.SPACE + text.replace(pieces.SPACE, pieces.LITERAL).replace(" ", pieces.SPACE)
    best = [[(0.0, ())]]
    for end in range(1, len(s) + 1):
        found = []
        for start in range(max(0, end - p.longest), end):
            piece = p.scores.get(s[start:end])
            if piece:
                found += [(score + piece[1], (*ids, piece[0])) for score, ids in best[start]]
        if s[end - 1] not in p.scores:
            raw = (pieces.SPACE if s[end - 1] == pieces.LITERAL else s[end - 1]).encode()
            found += [(score + p.unknown, (*ids, *(p.byte_ids[b] for b in raw))) for score, ids in best[end - 1]]
        best.append(sorted(found, reverse=True)[:n])
    return best[-1]


@pytest.mark.parametrize("text", TEXTS)
def test_scores_like_brute_force(model, text):
    ids, scores, every = model.encode(text)
    want = brute(model, text, 3)
    assert scores == pytest.approx([s for s, _ in want])
    value = {i: s for i, s in model.scores.values()}
    for path, score in zip(every, scores, strict=True):
        assert model.decode(path) == text
        if not set(path.tolist()) & set(model.byte_ids.values()):
            assert sum(value[i] for i in path.tolist()) == pytest.approx(score)
    assert len({x.tobytes() for x in every}) == len(every)
    assert ids.tolist() == every[0].tolist()


def test_round_trip_of_a_table(small_docs, small_texts, no_docs):
    got = pieces.encode_texts(small_docs, piece_model()).collect()
    assert len(got) == len(small_texts)
    assert all(r.decoded_equal and r.scores == sorted(r.scores, reverse=True) and len(r.ids) == r.n_pieces for r in got)
    assert all(hashlib.sha256(np.array(r.ids, np.int32).tobytes()).hexdigest() == r.digests[0] for r in got)
    assert pieces.encode_texts(no_docs, piece_model()).count() == 0
