import hashlib

import numpy as np

from tablewash.llm import chunks


def slow_ends(raw, bits, least, most):
    ends, at = [], 0
    for end in range(1, len(raw) + 1):
        h = 0
        for b in raw[max(0, end - chunks.WINDOW):end]:
            h = ((h << 1) + int(chunks.GEAR[b])) & 0xFFFFFFFF
        boundary = h >> (32 - bits) == 0 and end - at >= least
        if boundary or end - at == most or end == len(raw):
            ends.append(end)
            at = end
    return ends


def test_ends_like_a_rolling_loop():
    rng = np.random.default_rng(3)
    for size in (0, 1, 31, 33, 700, 3000):
        raw = rng.integers(97, 103, size).astype(np.uint8)
        assert chunks.chunk_ends(raw, 5, 16, 200) == slow_ends(raw.tobytes(), 5, 16, 200)


def test_like_brute_force(small_docs, small_texts):
    got = chunks.mark_repeated_chunks(small_docs).collect()
    places = {}
    want = {}
    # Rows that repeat an id are equal, so their order does not matter.
    for row, (i, text) in enumerate(sorted(small_texts, key=lambda x: (x[0] is None, x[0] or 0, x[1] is None))):
        raw = (text or "").encode()
        ends = chunks.chunk_ends(np.frombuffer(raw, np.uint8), 6, 32, 1024)
        gone = []
        for a, b in zip([0, *ends], ends):
            if places.setdefault(hashlib.sha256(raw[a:b]).digest(), (row, a)) != (row, a):
                gone.append((a, b))
        want.setdefault((-1 if i is None else i), []).append((len(raw), len(ends), len(gone), sum(b - a for a, b in gone)))
    have = {}
    for r in got:
        have.setdefault(-1 if r.doc_id is None else r.doc_id, []).append((r.n_bytes, r.n_chunks, r.n_repeated, r.n_removed))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    assert any(r.n_repeated for r in got)
    for r in got:
        assert sum(b - a for a, b in r.spans) == r.n_removed


def test_an_insertion_moves_boundaries_along():
    rng = np.random.default_rng(4)
    raw = rng.integers(97, 123, 20_000).astype(np.uint8)
    moved = np.concatenate([raw[:5000], np.frombuffer(b"inserted", np.uint8), raw[5000:]])

    def cut(x):
        ends = chunks.chunk_ends(x, 6, 32, 1024)
        return {x[a:b].tobytes() for a, b in zip([0, *ends], ends)}

    assert len(cut(raw) - cut(moved)) <= 5


def test_empty_table(no_docs):
    assert chunks.mark_repeated_chunks(no_docs).count() == 0
