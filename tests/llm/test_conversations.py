import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from tablewash.llm import conversations

WHITE = " \t\n\x0b\x0c\r"
LEGAL = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out[conv] += []
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        out[conv] += [(turn, role, text)] * (2 if fault == 3 else 1)
    return out


def cheapest(symbols):
    """(cost, audit, repaired roles by row) by a search over edit lists as plain strings."""
    @lru_cache(None)
    def best(i, state):
        ways = [(0, "", ())] if i == len(symbols) and state in ("", "a") else []
        following = "a" if state == "u" else "u"
        if i < len(symbols):
            initial, must_go, cut = symbols[i]
            options = [("D", 2, state, None)]
            if not must_go:
                extra = 5 if cut else 0
                options.append(("R", 1 + extra, following, (i, {"u": "user", "a": "assistant"}[following])))
                if initial == following or (initial == "s" and state == ""):
                    options.append(("K", extra, initial, (i, None)))
            for letter, cost, to, row in options:
                c, a, r = best(i + 1, to)
                ways.append((c + cost, letter + a, ((row,) if row else ()) + r))
        return min(ways, key=lambda w: w[:2], default=(10**9, "", ()))
    return best(0, "")


def model(rows):
    out = []
    for conv, own in damaged(rows).items():
        own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        seen, symbols, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            bare = text.strip(WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            symbols.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:]))
        cost, audit, kept = cheapest(tuple(symbols))
        fixed = "\n".join(f"{role or own[i][1]}:{own[i][2]}" for i, role in kept)
        out.append((str(conv), gaps, *counts.values(), illegal, cost, audit, hashlib.sha256(fixed.encode()).hexdigest()))
    return sorted(out)


def cases(seed, n, longest, ties=True):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"] * 6 + ["system", "tool", "", None, "Assistant"]) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = rng.choice(["Fine. ", "so it is!", "cut off here", "same.", "", " \n", None, f"own {rng.random()}?", f"own {rng.random()}"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3]) if rng.random() < 0.98 else None, role, text))
    rows += [(2000 + i, 0, "user", "Alone.") for i in range(60)]
    rows += [(None, t, "user", "no id.") for t in range(5)] + [(10**6, None, None, None)] + [(10**6 + 1, 7, "user", "Hi?")] * 3
    if not ties:
        rows = list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())
    return rows


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "conv_id bigint, turn bigint, role string, text string, file string, part bigint, symbol string")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((str(r.conv_id), *[r[c] for c in names]) for r in conversations.damage_and_repair(df.repartition(4)).collect())


@pytest.mark.parametrize("piece", [1024, 3])
def test_like_a_search_over_edit_lists(spark, monkeypatch, piece):
    monkeypatch.setattr(conversations, "PIECE", piece)
    rows = cases(piece, 150, 14)
    got, want = run(spark, rows), model(rows)
    assert got == want
    assert {len(w[7]) for w in want} >= {0, 3, 8} and all(set("KRD") & set(w[7]) for w in want if w[7])


def test_one_long_conversation_in_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(conversations, "PIECE", 50)
    rows = [(c, t, r, x) for _, t0, r, x in cases(9, 60, 12) for c, t in [(1, t0)]]
    rows = [(1, i, r, x) for i, (_, _, r, x) in enumerate(rows)] + cases(10, 20, 4)
    assert run(spark, rows) == model(rows)


def searched(symbols, rerole, delete, insert, cut):
    """(cost, audit) by a search over all edit lists with at most two rows put in at a time."""
    @lru_cache(None)
    def best(i, state, put):
        following = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        ways = [(0, "")] if i == len(symbols) and state in ("", "a") else []
        if put < 2:
            c, a = best(i, following, put + 1)
            ways.append((c + insert, "I" + a))
        if i < len(symbols):
            x, extra = symbols[i].lower(), cut if symbols[i].isupper() else 0
            c, a = best(i + 1, state, 0)
            ways.append((c + delete, "D" + a))
            if x != "x":
                c, a = best(i + 1, following, 0)
                ways.append((c + rerole + extra, "R" + a))
                if x == following or (x == "s" and state == ""):
                    c, a = best(i + 1, x, 0)
                    ways.append((c + extra, "K" + a))
        return min(ways, default=(10**9, ""))
    return best(0, "", 0)


def test_pieces_with_insertions(monkeypatch):
    for name, value in {"REROLE": 4, "DELETE": 5, "INSERT": 1, "TRUNCATED": 3}.items():
        monkeypatch.setattr(conversations, name, value)
    rng = random.Random(6)
    roles = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}
    for _ in range(300):
        symbols = "".join(rng.choice("suauauUAox") for _ in range(rng.randint(1, 9)))
        at = sorted(rng.sample(range(len(symbols) + 1), 2)) if len(symbols) > 1 else [0, 1]
        parts = [p for p in (symbols[:at[0]], symbols[at[0]:at[1]], symbols[at[1]:]) if p]
        cost, audit = conversations.join_pieces([conversations._decide(p) for p in parts])
        assert (cost, audit) == searched(symbols, 4, 5, 1, 3), symbols
        slices = conversations.cut_audit(audit, [len(p) for p in parts])
        assert "".join(slices) == audit
        stream = []
        for piece, part in zip(slices, parts):
            stream += [(piece, None, None), *[(None, roles[x.lower()], "t") for x in part]]
        fixed = "".join(role[0] for role, _ in conversations.repaired(iter(stream)))
        assert LEGAL.fullmatch(fixed) and len(fixed) == len(audit) - audit.count("D")


def test_weights_order_like_cost_and_audit():
    rng = random.Random(4)
    weights = conversations.Weights(6)
    pairs = [(rng.randrange(4), "".join(rng.choice("DIKR") for _ in range(rng.randrange(6)))) for _ in range(300)]
    assert sorted(pairs) == [weights.read(w) for w in sorted(weights.write(*p) for p in pairs)]
    cost, audit = pairs[5]
    assert weights.read(weights.before("K", 3, weights.write(cost, audit))) == (cost + 3, "K" + audit)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert conversations.damage_and_repair(empty).collect() == []
