import hashlib

import numpy as np
import pytest

from tablewash.llm import suffix


def model(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for t in raw:
        for i in range(len(t) - length + 1):
            seen[t[i:i + length]] = seen.get(t[i:i + length], 0) + 1
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = True
        runs = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
        out.append((len(t), int(gone.sum()), int((runs == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def test_like_brute_force(small_docs, small_texts, monkeypatch):
    got = suffix.remove_repeats(small_docs).collect()
    want = model([t for _, t in small_texts], 400)
    found = sorted((r.n_bytes, sum(r.ends) - sum(r.starts), len(r.starts), r.kept_sha256) for r in got)
    assert found == want
    assert sum(w[1] for w in want) > 5000 and any(0 < w[1] < w[0] for w in want)
    by_id = {r.doc_id: r for r in got}
    assert by_id[400].n_bytes == 0 and by_id[405].kept_text == "" and by_id[500].starts == []


def test_edges_of_repeats_are_exact(spark):
    rng = np.random.default_rng(5)
    letters = np.frombuffer(b"abcdefghij \n", np.uint8)
    draw = lambda n: letters[rng.integers(0, len(letters), n)].tobytes().decode()
    core = draw(1200)
    texts = [draw(50) + core[:399] + draw(60), core[100:499] + draw(30), core[100:500] + draw(30), draw(700) + core[500:1100], core + core[:401],
             draw(10) + core[650:1049], draw(399), "x" * 399, "y" * 401, "z" * 400, draw(400)]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    found = sorted((r.n_bytes, sum(r.ends) - sum(r.starts), len(r.starts), r.kept_sha256) for r in got)
    assert found == model(texts, 400)


def test_shorter_passages_and_two_lengths(spark, small_docs, small_texts):
    rng = np.random.default_rng(8)
    letters = np.frombuffer(b"abcdefghij \n", np.uint8)
    draw = lambda n: letters[rng.integers(0, len(letters), n)].tobytes().decode()
    core = draw(900)
    texts = [draw(50) + core[:271] + draw(60), draw(20) + core[40:312] + draw(90), draw(500) + core[300:700], draw(300) + core + draw(30),
             draw(100) + core[450:721], draw(271), "é" * 136, "x" * 273, None, ""]
    texts += [text for _, text in small_texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    one = suffix.remove_repeats(df, length=272, rounds=1).collect()
    assert sorted((r.n_bytes, sum(r.ends) - sum(r.starts), len(r.starts), r.kept_sha256) for r in one) == model(texts, 272)
    both = suffix.remove_repeats(df, passage=272).collect()
    assert sorted((r.n_bytes, sum(r.ends) - sum(r.starts), len(r.starts), r.kept_sha256) for r in both) == model(texts, 400)
    assert sorted((r.n_bytes, r.n_repeated) for r in both) == sorted(m[:2] for m in model(texts, 272))
    assert suffix.remove_repeats(df, length=336, rounds=2).count() == len(texts)
    with pytest.raises(ValueError):
        suffix.remove_repeats(df, passage=271)


def test_transform_is_a_burrows_wheeler_transform():
    data = np.frombuffer(b"banana split, banana bread; " * 30 + b"plain text " * 40, np.uint8)
    off = np.array([0, 300, 300, len(data)])
    bwt, lf, at = suffix.transform(data, off)
    assert sorted(lf.tolist()) == list(range(len(lf)))
    # Following the steps backward reads the phrases of all texts from last to first.
    starts = sorted(set(suffix.boundaries(data).tolist()) | {0, 300})
    i, seen = int(np.flatnonzero(at == -1)[1]), []
    for _ in range(len(lf)):
        seen.append(int(at[lf[i]]))
        i = int(lf[i])
    assert [s for s in seen if s >= 0][::-1] == starts or sorted(s for s in seen if s >= 0) == starts


def test_empty_table_and_short_length(no_docs):
    assert suffix.remove_repeats(no_docs).collect() == []
    with pytest.raises(ValueError):
        suffix.remove_repeats(no_docs, length=399)
