import zlib

import numpy as np
from pyspark.sql import functions as F

from tablewash.llm import sampling, toxicity

LABELS = "doc_id bigint, quality int, toxic int, text string"


def corpus(spark, n=3000):
    """A tenth of the texts is toxic: they hold a few words of their own."""
    rng = np.random.default_rng(2)
    rows, marks = [], []
    for i in range(n):
        toxic = i % 10 == 3
        words = [f"w{x}" for x in rng.integers(0, 300, 40)]
        if toxic:
            words[5:5] = [f"bad{x}" for x in rng.integers(0, 6, 4)]
        rows.append((i, " ".join(words), "en", "s", "x"))
        marks.append((i, 1, int(toxic), "clash"))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, toxic string, score string"), spark.createDataFrame(marks, LABELS)


def test_held_out_accuracy_and_blind_labels(spark):
    docs, labels = corpus(spark)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, toxicity.train(docs, labels)).collect()}
    assert len(got) == 3000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [r for r in got.values() if r.held_out]
    assert np.mean([r.predicted == int(r.doc_id % 10 == 3) for r in held]) >= 0.97
    # Labels of held-out rows change nothing.
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, toxicity.train(docs, turned)).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_prior_corrects_unlabelled_positives():
    rng = np.random.default_rng(0)
    bad = np.uint64(7)
    sets = [np.array([bad] if i < 400 else [], np.uint64) for i in range(600)] + [np.array([], np.uint64)] * 600
    sets = [np.unique(np.concatenate([s, rng.integers(100, 160, 8).astype(np.uint64)])) for s in sets]
    toxic = np.arange(1200) < 200  # 200 more toxic texts are among the 1000 unlabelled ones
    model = toxicity.fit(sets, toxic, 0.2)
    z = np.array([model.weights[np.isin(model.vocabulary, s)].sum() + model.bias for s in sets])
    assert (z[:400] > 0).all() and (z[400:] < 0).all()


def test_defined_cases(spark, small_docs, small_texts, no_docs):
    none = spark.createDataFrame([], LABELS)
    got = toxicity.score_toxicity(small_docs, toxicity.train(small_docs, none)).collect()
    assert len(got) == len(small_texts) and all(r.score == 0 and r.predicted == 0 for r in got)
    assert all(r.held_out for r in got if r.doc_id is None)
    unknown = spark.createDataFrame([(100, None, None, None), (None, 1, 1, None), (101, 0, 1, None), (101, 0, 0, None)], LABELS)
    assert toxicity.score_toxicity(small_docs, toxicity.train(small_docs, unknown)).count() == len(small_texts)
    assert toxicity.score_toxicity(no_docs, toxicity.train(no_docs, unknown)).count() == 0


def test_draw_is_bounded_and_takes_copies_one_by_one(spark):
    rows = [(i, "copy " * 20 if i % 3 else f"own {i}") for i in range(3000)] + [(None, None)] * 50 + [(7000, "x" * 5000)]
    df = spark.createDataFrame(rows, "id bigint, text string").repartition(7)
    got = sampling.bounded_draw(df, ["id", "text"], "text", 300, 100_000).collect()
    assert 250 <= len(got) <= 300 and sum(len(r.text or "") for r in got) <= 100_000
    copies = sum((r.text or "").startswith("copy") for r in got)
    assert 0.55 < copies / len(got) < 0.78 and all(len(r.text or "") < 1000 for r in got)
    again = sampling.bounded_draw(df.repartition(3), ["id", "text"], "text", 300, 100_000).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    few = sampling.bounded_draw(df, ["id", "text"], "text", 300, 5_000).collect()
    assert 0 < len(few) < 200 and sum(len(r.text or "") for r in few) <= 5_000
    same = spark.createDataFrame([(1, "same")] * 500, "id bigint, text string")
    assert sampling.bounded_draw(same, ["id", "text"], "text", 100, 10_000).count() == 100
