import random

import pytest

# Columns named like those the operators use inside; they must not get in the way.
EXTRA = ["id", "row", "label", "key", "n", "cls", "words", "grp", "shard", "digest"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in EXTRA)


def words(rng, n, letters="abcdefgh"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n)]


def texts():
    """(id, text): copies, near copies, shared passages, blank, NULL, long and repeated rows."""
    rng = random.Random(7)
    out = []
    base = words(rng, 150)
    passage = " ".join(words(rng, 90))
    for i in range(14):
        edited = list(base)
        for _ in range(i // 2):
            edited[rng.randrange(len(edited))] = "zz" + str(i)
        out.append((100 + i, " ".join(edited)))
    out += [(200 + i, " ".join([*words(rng, 40), passage, *words(rng, 30)])) for i in range(3)]
    out += [(300 + i, " ".join(words(rng, rng.randint(1, 60)))) for i in range(12)]
    out += [(400, None), (401, ""), (402, " \n\t "), (403, "one two"), (404, "ONE TWO"), (405, "a" * 3000), (406, "é" * 500 + " ▁ 😀\n\n x")]
    out += [(500, " ".join(words(rng, 9000))), (501, "ab " * 700), (None, " ".join(base)), (None, None)]
    out += [(300, out[17][1]), (300, out[17][1])]
    return out


@pytest.fixture(scope="session")
def small_texts():
    return texts()


@pytest.fixture(scope="session")
def small_docs(spark, small_texts):
    rows = [(i, t, "en" if (i or 0) % 3 else None, f"s{(i or 0) % 2}", None, *(["x"] * len(EXTRA))) for i, t in small_texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
