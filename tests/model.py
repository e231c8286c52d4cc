"""Slow sequential models of the fuzzy operators, written from the published definitions."""

import functools


@functools.lru_cache(maxsize=None)
def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def similarity(distance, total):
    return (1 - distance / total) * 100 if total else 100.0


def ratio(a, b):
    return similarity(len(a) + len(b) - 2 * lcs(a, b), len(a) + len(b))


def partial(a, b):
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    return max(
        ratio(a, b[max(0, i):min(m, i + n)]) for i in range(1 - n, m)
    )


def token_sort(a, b, scorer=ratio):
    return scorer(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = x & y, x - y, y - x
    if both and (not only_x or not only_y):
        return 100.0
    dx, dy = " ".join(sorted(only_x)), " ".join(sorted(only_y))
    shared = len(" ".join(both))
    gap = 1 if shared else 0
    lx, ly = shared + gap + len(dx), shared + gap + len(dy)
    best = similarity(len(dx) + len(dy) - 2 * lcs(dx, dy), lx + ly)
    if shared:
        best = max(best, similarity(1 + len(dx), shared + lx), similarity(1 + len(dy), shared + ly))
    return best


def partial_token(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    if x & y:
        return 100.0
    return max(
        partial(" ".join(sorted(a.split())), " ".join(sorted(b.split()))),
        partial(" ".join(sorted(x - y)), " ".join(sorted(y - x))),
    )


def weighted(a, b):
    if not a or not b:
        return 0.0
    spread = max(len(a), len(b)) / min(len(a), len(b))
    score = ratio(a, b)
    if spread < 1.5:
        return max(score, 0.95 * max(token_sort(a, b), token_set(a, b)))
    scale = 0.9 if spread <= 8 else 0.6
    score = max(score, partial(a, b) * scale)
    return max(score, partial_token(a, b) * 0.95 * scale)


CUT = 1e-9  # two equal rationals may differ in the last bit


def dedupe_model(values):
    """Positions kept by the sequential scan; NULL equals only NULL, '' is always kept."""
    kept, seen, null_seen = [], [], False
    known = {}
    for i, v in enumerate(values):
        if v is None:
            if not null_seen:
                kept.append(i)
            null_seen = True
        elif v == "":
            kept.append(i)
        elif v not in known:
            known[v] = any(weighted(v, s) >= 90 - CUT for s in seen)
            if not known[v]:
                seen.append(v)
                kept.append(i)
    return kept


def lookup_model(key, lookup_keys, cutoff=75):
    """Best lookup key (first among equals) or None."""
    if key in lookup_keys:
        return key
    best, found = cutoff - CUT, None
    for k in lookup_keys:
        score = weighted(key, k)
        if score >= cutoff - CUT and (found is None or score > best):
            best, found = score, k
    return found
