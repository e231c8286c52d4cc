import re

import numpy as np

from tablewash.llm import decontamination as dc


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def split(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(texts, items, share=0.25):
    out = set()
    for i, text in texts:
        w = split(text)
        for k, item in items:
            b = split(item)
            if not w or not b:
                continue
            found = min((distance(w[s:s + len(b)], b), s) for s in range(max(0, len(w) - len(b)) + 1))
            if found[0] <= len(b) * share:
                out.add((i, k, found[1], found[0], len(b)))
    return out


def test_like_brute_force(spark, small_texts):
    rng = np.random.default_rng(5)
    texts = [t for t in small_texts if len(t[1] or "") < 3000]
    source = [(i, split(t)) for i, t in texts if len(split(t)) >= 30]
    items = [("none", None), ("blank", " . "), ("one", "onlyword"), ("two", "one two")]
    for k, (_, w) in enumerate(source):
        n = int(rng.integers(8, 28))
        item = list(w[2:2 + n])
        for _ in range(int(rng.integers(0, n // 4 + 3))):
            item[int(rng.integers(len(item)))] = f"new{k}"
        if k % 3 == 0:
            del item[4]
        items.append((f"item{k}", " ".join(item).upper()))
    items.append(items[-1])
    rows = [(i, t, "x", "y", "z") for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, item string, hash string, n string").repartition(3)
    bench = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id string, text string, words string")
    got = dc.find_contamination(docs, bench).collect()
    want = brute(texts, items)
    found = {(r.doc_id, r.item_id, r.first_word, r.distance, r.item_words) for r in got}
    # Ties and later windows aside, each pair found is within the edits; the walks miss at most one in a hundred.
    assert {f[:2] for f in found} <= {w[:2] for w in want}
    assert len({w[:2] for w in want} - {f[:2] for f in found}) <= len(want) // 50
    assert sum(f in want for f in found) >= 0.9 * len(found) and len(found) > 20


def test_distances_of_many_windows():
    rng = np.random.default_rng(1)
    words = rng.integers(1, 5, 400).astype(np.uint64)
    starts = np.arange(0, 300, 7)
    ends = starts + rng.integers(0, 20, len(starts))
    items = [rng.integers(1, 5, int(rng.integers(1, 25))).astype(np.uint64) for _ in starts]
    want = [distance(words[a:b].tolist(), i.tolist()) for a, b, i in zip(starts, ends, items, strict=True)]
    assert dc.edit_distances(words, starts, ends, items).tolist() == want


def test_empty_tables(spark, no_docs, small_docs):
    none = spark.createDataFrame([], "item_id string, text string")
    assert dc.find_contamination(small_docs, none).count() == 0
    one = spark.createDataFrame([("a", "one two three")], "item_id string, text string")
    assert dc.find_contamination(no_docs, one).count() == 0
