import hashlib

from pyspark.sql import functions as F

from tablewash.llm import lines

WHITE = " \t\n\x0b\x0c\r"


def model(rows, min_chars=20, min_docs=3):
    """Brute force: rows of (id, text) to the sorted (id or -1, lines, dropped, digest)."""
    held = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            held.setdefault(key(line), set()).add((-1 if doc is None else doc, text or ""))
    out = []
    for doc, text in rows:
        own, kept = -1 if doc is None else doc, []
        for line in (text or "").split("\n"):
            docs = held[key(line)]
            if len(key(line)) < min_chars or len(docs) < min_docs or own == max(docs)[0]:
                kept.append(line)
        n = len((text or "").split("\n"))
        out.append((own, n, n - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def found(df, id_column="doc_id"):
    return sorted((-1 if r[id_column] is None else r[id_column], r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect())


COMMON = "Subscribe to our newsletter today"


def cases():
    rows = [(i, f"own line number {i} of this text\n {COMMON.upper() if i % 2 else COMMON}\t\nend {i}") for i in range(40)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (53, COMMON), (54, COMMON), (55, f"{COMMON}\n{COMMON}\n" * 200 + "tail of the long text, quite alone")]
    rows += [(60, "exactly 20 letters..\r\nnineteen letters..."), (61, "exactly 20 letters..\nnineteen letters..."), (62, "EXACTLY 20 letters..\nnineteen letters...")]
    rows += [(70, "ÄÖÜ is not lower-cased here\nin two only, not in three"), (71, "äöü is not lower-cased here\nin two only, not in three"), (72, "äöü is not lower-cased here")]
    rows += [(None, "no id, but a line of some length"), (None, "no id, but a line of some length\nagain"), (None, "no id, but a line of some length\nonce more")]
    rows += [(None, COMMON), (None, None), (80, "repeated row with a long line"), (80, "repeated row with a long line"), (80, "repeated row with a long line\nx"), (81, "repeated row with a long line")]
    rows += [(90 + i, "😀" * 20 + "\n" + "a" * 5000) for i in range(4)]
    rows += [(100 + i, "\n".join(f"line {j} of a block that moves" for j in range(i, i + 150))) for i in range(5)]
    return rows


def test_like_brute_force(spark):
    rows = cases()
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id bigint, text string, high string, slice int, content string").repartition(5)
    want = model(rows)
    assert found(lines.drop_repeated_lines(df)) == want
    assert sum(w[2] for w in want) > 600
    assert found(lines.drop_repeated_lines(df, min_chars=1, min_docs=2)) == model(rows, 1, 2)


def test_shared_documents(small_docs, small_texts):
    assert found(lines.drop_repeated_lines(small_docs, min_docs=2)) == model(small_texts, min_docs=2)


def test_bitmaps_hold_no_whole_words(spark):
    rows = [(i, "\n".join([f"line {j} stands in this text {i}" for j in range(300)] + ["the same last line in all texts"])) for i in range(4)]
    got = {r.doc: r for r in lines.keep_bitmaps(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sorted(got) == [0, 1, 2]
    assert [(w.word, w.keep) for w in got[0].words] == [(4, ~(1 << (300 % 64)))]


def test_empty_table(no_docs):
    assert lines.drop_repeated_lines(no_docs).collect() == []


def test_plan_is_native_and_keeps_texts_out_of_the_line_shuffle(small_docs):
    plan = lines.drop_repeated_lines(small_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    ranged = lines.occurrences(small_docs)
    assert not any(t == "string" for _, t in ranged.dtypes)
    marked = lines._first_marked(ranged)._jdf.queryExecution().executedPlan().toString()
    assert marked.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in marked
