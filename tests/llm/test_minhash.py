from collections import Counter, defaultdict

import numpy as np

from tablewash.llm.minhash import near_duplicates, sketch


def shingle_set(text):
    w = (text or "").encode().lower().split()
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def model(rows):
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    inverted, common = defaultdict(list), Counter()
    for i in sorted(sets):
        for s in sets[i]:
            common.update((j, i) for j in inverted[s])
            inverted[s].append(i)
    for (a, b), n in common.items():
        if 100 * n >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_like_brute_force(small_docs, small_texts):
    got = near_duplicates(small_docs).collect()
    assert len(got) == len(small_texts)
    want = model(small_texts)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == want
    assert len({v[1] for v in want.values()}) < len(want) - 5
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)


def test_open_buckets_are_settled_by_prefixes(spark):
    # Two families that share bands but are linked only within themselves, and links away from the pivot.
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):
        edited = list(base)
        for p in rng.choice(120, rng.integers(0, 9), replace=False):
            edited[p] = f"e{p}-{i % 5}"
        rows.append((i, " ".join(edited)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), coordinates=64, band_rows=1).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == model(rows)


def test_empty_table(no_docs):
    assert near_duplicates(no_docs).collect() == []


def test_every_coordinate_is_filled_and_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    universe = rng.integers(1, 2**63, 600).astype(np.uint64)
    sets = [universe[:1], universe[:3], universe[:400], universe[100:500]]
    s = sketch(np.concatenate(sets), np.repeat(np.arange(4), [len(x) for x in sets]), 4, 256, 1)
    assert (s != np.uint64(2**64 - 1)).all()
    assert abs((s[2] == s[3]).mean() - 300 / 500) < 0.12
