import re

from pyspark.sql import functions as F

from tablewash.llm.quality import quality

WORD = re.compile("[^\x20\x09-\x0D]+")


def base(text):
    w = WORD.findall(text or "")
    places = {}
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i:i + 8]), []).append(i)
    covered = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_base_counts_like_brute_force(small_docs, small_texts):
    got = quality(small_docs).collect()
    key = lambda r: (-1 if r[0] is None else r[0], *r[1:])
    want = sorted(((i, *base(t), base(t)[0] < 20 or 100 * base(t)[4] > 30 * base(t)[0]) for i, t in small_texts), key=key)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=key) == want
    assert all(not r.kept for r in got if r.base_failed)


def test_outliers_go_and_clean_texts_stay(spark):
    clean = "concat_ws(' ', transform(sequence(1, 60 + CAST(id % 50 AS int)), i -> substr(md5(concat(id, '-', i)), 1, 3 + CAST((id + i) % 5 AS int))))"
    docs = spark.range(1200).select(
        F.col("id").alias("doc_id"), F.expr(f"CASE WHEN id % 40 = 7 THEN replace({clean}, ' ', ' ### ') ELSE {clean} END").alias("text"),
        F.expr("CASE WHEN id % 3 = 0 THEN 'en' ELSE 'fr' END").alias("lang"), F.expr("CASE WHEN id % 2 = 0 THEN 'hot' ELSE 'tiny' || id END").alias("source"))
    got = {r.doc_id: r for r in quality(docs).collect()}
    assert [i for i, r in got.items() if r.kept] == [i for i in got if i % 40 != 7]


def test_main_path_is_native(small_docs):
    plan = quality(small_docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table(no_docs):
    assert quality(no_docs).collect() == []
