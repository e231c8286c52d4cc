import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tablewash.llm.store import written


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(11)

    def text(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))

    passage, leak = text(100), text(20)
    clean = {i: text(120) for i in range(60)}
    docs = dict(clean)
    docs[100] = clean[3] + " more"                    # near copy of 3
    docs[101] = clean[4]                              # copy of 4
    docs[102] = text(80) + " " + leak + " " + text(60)  # holds a benchmark item
    docs[103], docs[104] = text(200) + passage + text(150), text(210) + passage + text(140)
    docs[105] = "short"
    docs[106] = text(12) + " " + "again and again we say the same eight words " * 20
    rows = [(i, t, "en", "web", None if t is None else len(t), "x") for i, t in docs.items()] + [(None, text(80), "en", "web", 5, "x"), (107, None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("a", leak)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(clean) | {103, 104, None}
    assert all(r.decoded_equal and r.n_pieces > 0 for r in got.values())
    assert got[103].n_pieces < 1.2 * max(got[i].n_pieces for i in clean) * 350 / 120


def test_names_and_columns(spark, no_docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "minhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "sentence_pieces"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_each_row_keeps_its_own_verdict(spark, tmp_path):
    rng = random.Random(12)

    def text(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))

    leak, copied, passage = text(20), text(90), text(100)
    rows = [(1, text(60)), (1, text(70)), (1, "short"), (1, text(40) + " " + leak + " " + text(40)),
            (None, text(50)), (None, text(55)), (None, "short"), (None, text(30) + " " + leak + " " + text(30)),
            (5, copied), (2, copied), (2, copied), (None, copied), (None, copied),
            (3, text(200) + passage + text(150)), (3, text(210) + passage + text(140)), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in ("lang", "source")})
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("a", leak)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        kept[name] = docs.collect()
    want = [r for r in rows if r[1] not in ("short", None)]
    assert Counter((r.doc_id, r.text) for r in kept["quality_rules"]) == Counter(want)
    want = [r for r in want if r[1] != copied] + [(2, copied)]
    assert Counter((r.doc_id, r.text) for r in kept["minhash_near_dedup"]) == Counter(want)
    last = Counter(r.doc_id for r in kept["suffix_array_dedup"])
    assert last == Counter(r[0] for r in want)
    assert all(passage not in r.text for r in kept["suffix_array_dedup"])
    want = [r for r in want if leak not in r[1]]
    assert Counter(r.doc_id for r in kept["benchmark_decontamination"]) == Counter(r[0] for r in want)
    assert {r.text for r in kept["benchmark_decontamination"] if r.doc_id != 3} == {r[1] for r in want if r[0] != 3}
    assert Counter(r.doc_id for r in kept["sentence_pieces"]) == Counter({1: 2, None: 2, 2: 1, 3: 2})
