import random
import re
from collections import Counter, defaultdict

import numpy as np

from tablewash.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def model(rows, min_docs=30, top=50):
    """Brute force over (lang, source, text)."""
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        words = TERM.findall((text or "").translate(LOWER))
        docs[lang or ""].update(set(words))
        counts[lang or "", source or ""].update(words)
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        groups = {s: c for (g, s), c in counts.items() if g == lang}
        whole = Counter()
        for c in groups.values():
            whole.update(c)

        def prices(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q, p = prices(whole), {s: prices(c) for s, c in groups.items()}
        for s in groups:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in groups if o != s]
            term = [(q[t] - p[s][t], t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, item.decode(), -value, i) for i, (value, item) in enumerate(items, 1)]
    return sorted(out)


def cases(seed, n=300):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ab", "Éc", "zz", "日", "x") for b in "abcdefghijklmnop"]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "en", "fr", None]), rng.choice(["hot"] * 5 + ["s1", "s2", "s3", None, "empty"])
        text = None if source == "empty" else rng.choice(["", ", ", "-"]).join([""]) + rng.choice([" ", "1", "_"]).join(
            rng.choice(vocabulary[: rng.choice([5, 20, 80])]) for _ in range(rng.randint(0, 40)))
        rows.append((lang, source, text))
    rows += [("rare", "a", "words in too few texts"), ("rare", "b", None), ("rare", None, "x"), ("one", "only", "alone")]
    rows += [("en", "long", "tick Tock " * 30_000), ("en", "hot", rows[0][2]), ("en", "hot", rows[0][2])]
    return rows


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "y", 2) for r in rows], "lang string, source string, text string, n int, term string, price int")
    return sorted(tuple(r) for r in divergence.source_divergence(df.repartition(6), **options).collect())


def test_like_brute_force(spark):
    rows = cases(1)
    want = model(rows, top=10)
    assert run(spark, rows, top=10) == want
    assert {w[2] for w in want} == {"pair", "term"} and any(w[0] == "rare" and w[4] == 0 for w in want)


def test_small_blocks_and_flushes_give_the_same(spark, monkeypatch):
    rows = cases(2)
    want = model(rows, min_docs=3)
    divergence_blocks = {"BLOCK_TERMS": 7, "BLOCK_GROUPS": 2}
    for name, value in divergence_blocks.items():
        monkeypatch.setattr(divergence, name, value)
    assert run(spark, rows, min_docs=3) == want


def test_terms_are_cut_in_pieces(monkeypatch):
    text = "Eins zwei,DREI é1É _x" * 5
    whole = [w for words in divergence.terms_of(text.encode()) for w in words]
    monkeypatch.setattr(divergence, "PIECE", 4)
    assert [w for words in divergence.terms_of(text.encode()) for w in words] == whole
    assert [w.decode() for w in whole] == TERM.findall(text.translate(LOWER))


def test_joint_prices_split_by_terms(monkeypatch):
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 6, (50, 4)) * rng.integers(0, 2, (50, 4))
    counts[:, 0] += 1
    prices = np.cumsum(rng.integers(1, 9, (4, 8)), axis=1).astype(float)
    term, group = np.nonzero(counts)
    own = np.stack([prices[g][counts[:, g]] for g in range(4)], axis=1)
    want = np.abs(own[:, :, None] - own[:, None, :]).sum(axis=0)
    args = (term, group, counts[term, group], own[term, group], prices[:, 0])
    assert (divergence.joint_prices(*args) == want).all()
    monkeypatch.setattr(divergence, "BLOCK_COLUMNS", 6)
    assert (divergence.joint_prices(*args) == want).all()


def test_empty_table(no_docs):
    assert divergence.source_divergence(no_docs).collect() == []
