"""The batch scorers against slow definitions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewash.functions import similarity as S
from tests import model


def pairs(seed, n, longest):
    rng = random.Random(seed)
    def text():
        words = ["".join(rng.choice("abcé😀") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(0, longest))]
        return rng.choice([" ", "  ", "\t"]).join(words)
    out = []
    for _ in range(n):
        a = text()
        b = rng.choice([text(), a, " ".join(reversed(a.split())), a[: len(a) // 2], a + " " + text(), a.replace("a", "b", 1)])
        out.append((a, b))
    return out + [("", ""), ("", "a"), ("a" * 64, "a" * 64 + "b"), ("ab" * 40, "ba" * 70), ("x\0y", "xy\0"), (" ", "a b")]


def test_lcs_and_ratio_of_batches(monkeypatch):
    cases = pairs(1, 400, 14)
    a, b = map(list, zip(*cases))
    assert S.lcs_lengths(a, b).tolist() == [model.lcs(x, y) for x, y in cases]
    assert S.ratios(a, b) == pytest.approx([model.ratio(x, y) for x, y in cases])
    monkeypatch.setattr(S, "BLOCK", 200)
    assert S.lcs_lengths(a, b).tolist() == [model.lcs(x, y) for x, y in cases]
    assert S.lcs_lengths([], []).tolist() == []


def test_partial_and_weighted_scores_of_batches(monkeypatch):
    monkeypatch.setattr(S, "WINDOWS", 50)
    cases = [(x, y) for x, y in pairs(2, 250, 5) if x and y and "\t" not in x + y]
    a, b = map(list, zip(*cases))
    assert S.partial_ratios(a, b) == pytest.approx([model.partial(x, y) for x, y in cases])
    assert S.weighted_scores(a, b) == pytest.approx([model.weighted(x, y) for x, y in cases])


def test_columns(spark):
    rows = [("Coca-Cola", "Coca Cola Inc"), ("Ahmed", "Ahmad"), (None, "a"), ("", "a"), ("b a", "A  b"), ("x", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(S.wratio(F.col("a"), F.col("b")), S.wratio(F.col("a"), F.col("b"), "default")).collect()
    assert got[0][0] == pytest.approx(model.weighted(*rows[0])) and got[0][1] == pytest.approx(model.weighted("coca cola", "coca cola inc"))
    assert got[1][0] == 80.0 and got[2][0] is None and got[3][0] == 0.0 and got[4][1] == pytest.approx(95.0) and got[5][1] is None
    with pytest.raises(ValueError):
        S.preprocessed(F.col("a"), "other")
