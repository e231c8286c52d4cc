"""Fuzzy operators against slow sequential models."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewash import CleaningConfig, clean, lookup_join
from tablewash.functions import similarity
from tablewash.operators.candidates import ratio_rule, window_rule
from tablewash.operators.fuzzy_dedupe import dedupe_fuzzy
from tablewash.operators.ordering import with_row_id
from tests import model


def some_word(rnd, letters="abcde", sizes=(1, 2, 3, 4, 5, 7, 9)):
    return "".join(rnd.choice(letters) for _ in range(rnd.choice(sizes)))


def mutate(rnd, text, letters):
    chars = list(text)
    for _ in range(rnd.choice([1, 1, 2, 3])):
        kind, i = rnd.randrange(4), rnd.randrange(len(chars) + 1)
        if kind == 0:
            chars.insert(i, rnd.choice(letters))
        elif chars and kind == 1:
            chars.pop(min(i, len(chars) - 1))
        elif chars and kind == 2:
            chars[min(i, len(chars) - 1)] = rnd.choice(letters)
        else:
            words = "".join(chars).split(" ")
            rnd.shuffle(words)
            chars = list(" ".join(words))
    return "".join(chars)


def messy_column(seed, n):
    """Near copies, reordered words, a hot prefix, repeated words, NULLs and blanks."""
    rnd = random.Random(seed)
    pool = [" ".join(some_word(rnd) for _ in range(rnd.choice([1, 1, 2, 3, 4]))) for _ in range(30)]
    pool += [f"Customer#{i:09d}" for i in range(15)]
    pool += ["international international organization", "international organizatiom", "ab " * 9 + "ab", "long name " * 9]
    values = []
    for _ in range(n):
        r = rnd.random()
        if r < 0.03:
            values.append(rnd.choice([None, None, ""]))
            continue
        value = mutate(rnd, rnd.choice(pool), "abcdexyz ")
        values.append(value)
        if rnd.random() < 0.3:
            pool.append(value)
    return values


@pytest.mark.parametrize("seed,window", [(1, 64), (2, 3)])
def test_fuzzy_dedupe_equals_the_sequential_scan(spark, seed, window):
    values = messy_column(seed, 350)
    df = spark.createDataFrame(list(enumerate(values)), "_rid long, v string")
    got = sorted(r[0] for r in dedupe_fuzzy(df, "v", window).select("_rid").collect())
    assert got == model.dedupe_model(values)


def test_null_is_no_text(spark):  # V6
    df = spark.createDataFrame([(1, None), (2, "banana"), (3, None), (4, ""), (5, "")], "_rid long, v string")
    assert sorted(r[0] for r in dedupe_fuzzy(df, "v").collect()) == [1, 2, 4, 5]


def test_documented_pairs():
    assert model.ratio("Ahmed", "Ahmad") == pytest.approx(80)
    assert model.ratio("Coca-Cola", "Coca Cola Inc") == pytest.approx(72.7, abs=0.1)
    assert model.weighted("banana", "nan") >= 90 - 1e-9
    assert model.lookup_model("cocacola", ["cocacolainc"]) == "cocacolainc"
    assert model.lookup_model("ab", ["abcdefghijklmnopqrst"]) is None


def test_fuzzy_lookup_equals_the_model(spark):
    rnd = random.Random(5)
    sizes = (1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 13, 14, 15, 17, 20, 24, 30, 70)
    lookup = [some_word(rnd, "abcde12", sizes) for _ in range(120)]
    keys = []
    for _ in range(600):
        key = mutate(rnd, rnd.choice(lookup), "abcdexyz")
        r = rnd.random()
        if r < 0.15:
            key = some_word(rnd, "abcde12", sizes) + key
        elif r < 0.3:
            key += some_word(rnd, "abcde12", sizes)
        elif r < 0.4:
            key = key[len(key) // 2:]
        keys.append(key.replace(" ", ""))
    firsts = list(dict.fromkeys(lookup))
    main = spark.createDataFrame(list(enumerate(keys)), "_rid long, k string")
    sec = spark.createDataFrame([(i, k, k) for i, k in enumerate(lookup)], "_rid long, kk string, got string")
    got = {r["_rid"]: r["got"] for r in lookup_join(main, sec, "k", "kk", fuzzy=True).df.collect()}
    expected = {i: model.lookup_model(k, firsts) if k else None for i, k in enumerate(keys)}
    assert got == expected


def test_fuzzy_steps_in_the_job(spark):
    main = spark.createDataFrame([(1, "Ahmad", "Acme Limited"), (2, "Ahmed", "Acme Limitd"), (3, "Zoe", "Other")],
                                 "k long, who string, firm string")
    sec = spark.createDataFrame([(1, "ahmed", 5)], "n long, name string, points long")
    config = CleaningConfig(merge_active=True, merge_key_main="who", merge_key_sec="name", merge_fuzzy=True,
                            remove_duplicates=True, dedupe_column="firm", fuzzy_dedupe=True)
    result = clean(main, config, sec, order_by="k", lookup_order_by="n")
    assert [(r["k"], r["points"]) for r in result.df.orderBy("k").collect()] == [(1, 5), (3, None)]
    assert [tuple(r) for r in result.log().collect()] == [(0, "merged", 2), (6, "fuzzy_duplicates", 1)]


def test_scorer_columns(spark):
    df = spark.createDataFrame([("abc", "abxc"), ("", ""), ("nan", "banana"), (None, "a")], "a string, b string")
    rows = df.select(
        similarity.lcs_length(F.col("a"), F.col("b")), similarity.indel_ratio(F.col("a"), F.col("b")),
        similarity.partial_ratio(F.col("a"), F.col("b")),
    ).collect()
    assert [r[0] for r in rows] == [3, 0, 3, None]
    assert [r[1] and round(r[1], 2) for r in rows] == [85.71, 100.0, 66.67, None]
    assert rows[2][2] == 100.0


texts = st.text(alphabet="abcd", max_size=14)


@settings(max_examples=300, deadline=None)
@given(texts, texts)
def test_bit_parallel_lcs(a, b):
    assert similarity.lcs_of(a, b) == model.lcs(a, b)


@settings(max_examples=300, deadline=None)
@given(texts.filter(len), texts.filter(len))
def test_partial_ratio_is_the_best_window(a, b):
    short, long = sorted((a, b), key=len)
    assert similarity.partial_of(short, long) == pytest.approx(model.partial(short, long))


def grams_of(text, q, stride=1):
    return [text[i:i + q] for i in range(0, len(text) - q + 1, stride)]


@settings(max_examples=1500, deadline=None)
@given(texts.filter(len), texts.filter(len), st.sampled_from([75, 90]), st.randoms(use_true_random=False))
def test_rules_never_miss_a_pair(a, b, cutoff, rnd):
    """Whatever grams count as frequent, the published ones reach every similar partner."""
    short, long = sorted((a, b), key=len)
    checks = []
    if short != long and model.ratio(short, long) >= cutoff - model.CUT:
        checks.append(ratio_rule(len(short), cutoff))
    if 1.5 * len(short) <= len(long) <= 8 * len(short) and 0.9 * model.partial(short, long) >= cutoff - model.CUT:
        checks.append(window_rule(len(short), cutoff))
    for rule in checks:
        assert rule is not None and rule.partner_min <= len(long) <= rule.partner_max
        published = grams_of(short, rule.gram, rule.stride)
        order = {g: rnd.random() for g in published}
        kept = sorted(published, key=order.get)[:len(published) - max(rule.skippable, 0)]
        assert set(kept) & set(grams_of(long, rule.gram))


def test_fuzzy_plans_have_no_cross_join(spark):
    from tablewash.operators.lookup import scored_candidates
    a = spark.createDataFrame([("abcdefgh",)], "key_text string")
    plan = scored_candidates(a, a, 75)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_chains_are_decided_by_pointer_doubling(spark):
    """Jobs grow with the logarithm of a chain; a branch, a kept neighbour and an undecidable root are respected."""
    from tablewash.operators import fuzzy_dedupe as fd

    def settle(n, extra=(), incomplete=()):
        ids = spark.range(n).select("id", F.col("id").isin(list(incomplete)).alias("incomplete"), F.lit(fd.OPEN).alias("status"))
        edges = spark.range(1, n).select(F.col("id").alias("later"), (F.col("id") - 1).alias("earlier"))
        if extra:
            edges = edges.unionByName(spark.createDataFrame(list(extra), "later bigint, earlier bigint"))
        group = f"chain-{n}-{len(extra)}"
        spark.sparkContext.setJobGroup(group, group)
        out = {r.id: r.status for r in fd._settle(ids, edges.distinct()).collect()}
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    def scan(n, extra=()):
        near = {}
        for a, b in [*((i, i - 1) for i in range(1, n)), *extra]:
            near.setdefault(a, set()).add(b)
        kept = set()
        for i in range(n):
            if not near.get(i, set()) & kept:
                kept.add(i)
        return {i: fd.KEPT if i in kept else fd.DROPPED for i in range(n)}

    short, few = settle(100)
    long, many = settle(10_000)
    assert short == scan(100) and long == scan(10_000)
    assert many <= 2.5 * few
    extra = [(50, 47), (200, 5), (201, 6)]
    assert settle(300, extra)[0] == scan(300, extra)
    waiting = settle(50, incomplete=[20])[0]
    assert all(waiting[i] == scan(50)[i] for i in range(20)) and waiting[20] == fd.OPEN and all(waiting[i] == fd.OPEN for i in range(21, 50))


@pytest.mark.parametrize("threshold", [62, 83, 90, 94])
def test_lookup_threshold(spark, threshold):
    rnd = random.Random(threshold)
    keys = ["".join(rnd.choice("abcd") for _ in range(rnd.choice([3, 5, 8, 12, 20]))) for _ in range(60)]
    asked = []
    for _ in range(60):
        k = rnd.choice(keys)
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(k))
            k = k[:i] + rnd.choice(["", "x", "ab"]) + k[i + 1:]
        asked.append(rnd.choice([k, "yy" + k + "zzz", k + k]) or "q")
    main_df = spark.createDataFrame(list(enumerate(asked)), "i int, k string")
    sec = spark.createDataFrame(list(enumerate(keys)), "j int, key string")
    got = lookup_join(with_row_id(main_df, "i"), with_row_id(sec, "j"), "k", "key", fuzzy=True, threshold=threshold).df
    firsts = {}
    for j, key in enumerate(keys):
        firsts.setdefault(key, j)
    for row in got.collect():
        scores = {j: model.weighted(row.k, key) for key, j in firsts.items()}
        best = max(scores.values())
        if row.k in firsts:
            assert row.j == firsts[row.k]
        elif best < threshold - model.CUT:
            assert row.j is None
        else:
            assert scores[row.j] == pytest.approx(best)


def test_lookup_threshold_is_checked(spark):
    df = with_row_id(spark.range(1).withColumn("k", F.lit("a")), "id")
    for wrong in (60, 101, 75.5):
        with pytest.raises(ValueError, match="threshold"):
            lookup_join(df, df, "k", "k", fuzzy=True, threshold=wrong)
